"""Column functions: text similarity, vectors, identifiers.  All stay in the JVM."""
