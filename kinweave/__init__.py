"""kinweave: entity resolution and identity governance as Spark DataFrame transformations."""
