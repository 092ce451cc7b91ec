"""Operators: functions from DataFrame(s) and a spec to a DataFrame."""
