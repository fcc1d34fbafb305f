"""Part of plumbline: streaming."""
