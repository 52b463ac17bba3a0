"""Tables, event-log and REST sources, and sinks."""
