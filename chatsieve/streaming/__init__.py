"""Curation of files as they come; the other row-local steps (``render_chat``,
``with_response_score``) run on a streaming DataFrame as they are."""
