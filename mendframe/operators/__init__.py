"""DataFrame operators, one function per measurement, search or edit."""
