"""Path tables that grow with a stream of graphs."""
