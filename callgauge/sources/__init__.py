"""Sources and sinks: table readers, adapters over the shared test tables, and
the partitioned event-log sink."""
