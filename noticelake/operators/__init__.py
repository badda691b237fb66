"""Relational operators over the tables of :mod:`noticelake.schemas`."""
