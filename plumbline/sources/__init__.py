"""Part of plumbline: sources."""
