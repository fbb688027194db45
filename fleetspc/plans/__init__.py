"""Compositions of operators: table set-up and the tables users ask for."""
