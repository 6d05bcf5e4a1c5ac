"""Sources and sinks: event-derived swipe exports, CSV, landing folders, tables."""
