"""Sources and sinks: files, HTTP, queues, object stores, search, change data capture."""
