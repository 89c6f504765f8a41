"""See the package docstring of nearbox."""
