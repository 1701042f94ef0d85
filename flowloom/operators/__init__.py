"""Operators over tables of program facts and over flows."""
