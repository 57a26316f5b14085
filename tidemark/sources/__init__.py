"""Where tables come from: test tables, snapshots, repositories."""
