"""Writers of stable reports and projections."""
