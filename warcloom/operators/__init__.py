"""Operators over records: filtering, HTTP decoding, extraction, verification."""
