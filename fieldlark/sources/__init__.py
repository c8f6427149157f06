"""Sources and sinks: table adapters, text and CSV readers, writers, dataset definitions."""
