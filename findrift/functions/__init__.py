"""Column functions: canonical forms, versioned hashes and path algebra."""
