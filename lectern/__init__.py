"""Spark jobs over an annotated text corpus and the speech timed against it.

Every public function takes DataFrames (or columns) and returns a DataFrame (or
a column); nothing here runs an action unless its docstring says so.
"""
