"""The engine has no streaming operators: both snapshots are computed in one batch."""
