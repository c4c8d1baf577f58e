"""DataFrame operators: chunking, concepts, clustering, deduplication, citations, edges, graphs, retrieval, usage."""
