"""Part of quillspark."""
