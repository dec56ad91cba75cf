"""The two errors callers are expected to catch."""


class DataIngestionError(Exception):
    """A table could not be read, is empty, or has unusable columns."""


class DocumentIngestionError(Exception):
    """A supporting document could not be loaded, split or embedded."""
