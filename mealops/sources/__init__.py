"""Sources and sinks: typed loads, bindings, parsers, writers."""
