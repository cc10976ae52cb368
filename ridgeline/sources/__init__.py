"""Sources, sinks, schemas and the fixture views over the test tables."""
