"""Reports composed from the operators.

Every log report groups by business day as well: give it one day (`scan_day`) for the live report, or the
whole log to compute the report of every day in one job.
"""
