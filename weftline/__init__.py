"""weftline: a schema-aware relational data engine on PySpark."""
