"""Sources: driver tables seen as logs, wire formats, stored tables."""
