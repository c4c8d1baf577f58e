"""Reading documents, pages and graph files, and writing graphs."""
