"""DataFrame operators: lines, rows, extraction, matching, checks, confidence."""
