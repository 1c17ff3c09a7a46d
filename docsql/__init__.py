"""docsql: document and table analytics expressed as Spark DataFrames."""
