"""Sources and sinks: driver tables, CSV uploads, synthetic rows, report files."""
