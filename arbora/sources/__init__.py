"""Sources, sinks and derived input views."""
