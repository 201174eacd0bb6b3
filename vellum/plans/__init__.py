"""Query modules; importing this package registers them all."""

from vellum.plans import draft_queries, edit_queries, face_queries, grouping_queries, ink_queries, last_queries, layout_queries, more_queries, other_queries, page_queries, registry, spatial_queries, style_queries, text_queries  # noqa: F401
