"""Row generators that turn one clip row into its frame schedule."""
