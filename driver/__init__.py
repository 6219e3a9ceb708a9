"""The library's queries applied to the generated test tables, and their SQL twins."""
