"""loomgraph: code-graph analytics over many repositories, written for Spark."""
