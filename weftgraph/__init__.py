"""weftgraph: annotation graphs and data-quality operators on Apache Spark."""
