"""Column expressions. Nothing here triggers a job or leaves the JVM."""
