"""Plans that span several Spark jobs."""

from arbora.plans.stash import drop, load, save, shared_dir, stash, temporary

__all__ = ["drop", "load", "save", "shared_dir", "stash", "temporary"]
