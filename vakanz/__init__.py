"""Job-posting analytics as Spark DataFrame jobs.

Landed web pages become links, typed postings and headed sections; sections about tasks,
requirements and benefits are found by weighted and fuzzy heading search, and their typical
terms are reported by a frequency rank slice.
"""
