"""The tables in the shared folder that operators of this package read again."""

from flowloom.tables import SETTING, forget, keep, new_path, shared_dir, small

__all__ = ["SETTING", "forget", "keep", "new_path", "shared_dir", "small"]
