"""Sources and sinks: files, admission, result log, exports."""
