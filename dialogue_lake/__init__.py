"""Spark-native analytics over recorded conversations.

Every record kind is a DataFrame keyed by ``meeting_id`` and every operator handles
all meetings at once.
"""
