"""Per-iteration frame sinks (trajectory, metrics, viewer export)."""
