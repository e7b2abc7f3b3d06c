"""Tables that change by whole commits."""
