"""Where elements, relations and references come from."""
