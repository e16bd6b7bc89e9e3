"""Reading tables, dumps and changes; writing documents."""
