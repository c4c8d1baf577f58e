"""Knowledge-graph, retrieval and graph-maintenance jobs as Spark DataFrame transformations."""
