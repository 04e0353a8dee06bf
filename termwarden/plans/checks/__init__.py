"""The checks themselves, one function each, from a release to a DataFrame.

Counts are taken per key before a join wherever several rows may share the key, and
multiplied afterwards: a value that holds much of a table is then combined map-side
instead of meeting its partners row by row. Set membership is an explicit semi or anti
join on distinct keys.
"""
