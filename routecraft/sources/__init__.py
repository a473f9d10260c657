"""Sources and sinks: test tables, the fact mapping, scenarios and file formats."""
