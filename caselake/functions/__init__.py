"""Scalar functions: plain Column to Column, no Python UDF."""

from .scalars import *  # noqa: F403
