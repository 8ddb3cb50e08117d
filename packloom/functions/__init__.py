"""Column expressions: nothing here leaves the JVM, save exact BPE counts."""
