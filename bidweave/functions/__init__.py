"""Column expressions; all of them stay in the JVM unless a docstring says otherwise."""
