"""Matrix sources (generators, files) and result sinks."""
