"""Where rows come from and where state is kept."""
