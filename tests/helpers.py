"""Helpers that several test modules import."""


def by_id(df):
    return {r["txn_id"]: r for r in df.collect()}
