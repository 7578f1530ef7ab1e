"""End-to-end programs: files in, files out, built from the operators."""
