"""Composed flows: preprocessing, generators, imputation, evaluation, whole runs."""
