"""Column expressions: each takes and returns Spark columns, none needs Python workers."""
