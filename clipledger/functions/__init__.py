"""Column expressions shared by the operators; no DataFrame work here."""
