"""Queries over the driver's tables; importing this package registers them."""

from . import q_artists, q_boards, q_bodies, q_columns, q_exports, q_extra, q_feeds, q_golden, q_images, q_matching, q_more, q_profiles, q_rollups, q_scores, q_search, q_sequences, q_vendors  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
