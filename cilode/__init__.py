"""Mining of CI configuration files, and of any other text or YAML column, with Spark."""
