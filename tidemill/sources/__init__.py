"""Sources and sinks: tables, collections, files, sockets, Kafka."""
