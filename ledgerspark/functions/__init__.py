"""Column helpers: numbers, text, similarity, checks. JVM-side expressions only."""
