"""Preference-data and reward analytics as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` (``rewardlens.operators``)
or ``Column -> Column`` (``rewardlens.functions``) function, so it composes
with ``df.transform`` and leaves planning to Catalyst.
"""

from rewardlens.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
