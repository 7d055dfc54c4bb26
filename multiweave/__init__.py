"""multiweave: one analytics engine on Spark for tables, documents, series, text, vectors, graphs, places and history."""
