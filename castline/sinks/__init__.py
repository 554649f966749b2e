"""Writers of levels, exports with their manifest, and the text corpus."""
