"""Document collections to ranked, budgeted answer context, as DataFrame transformations."""
