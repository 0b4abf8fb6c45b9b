"""lectern: a PySpark engine for finding, checking and organising passages in long texts."""
