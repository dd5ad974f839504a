"""Plan helpers: scratch tables, bounded joins, graph iterations."""
