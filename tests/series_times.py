"""Hours of the test series; a module of its own, for every test folder has a ``conftest``."""

import datetime as dt

T0 = dt.datetime(2024, 1, 1)


def hour_of(t):
    return int((t - T0).total_seconds() // 3600)
