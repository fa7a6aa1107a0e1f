"""Part of tracklane."""
