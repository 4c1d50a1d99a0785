"""Registered queries; importing the package registers all of them."""

from quillspark.plans import catalogue, lifecycle  # noqa: F401
