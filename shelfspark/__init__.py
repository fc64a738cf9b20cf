"""File-library and document analytics expressed as DataFrame operators."""
