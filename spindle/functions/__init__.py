"""Part of spindle."""
