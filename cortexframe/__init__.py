"""Multichannel biosignal analytics as DataFrame-to-DataFrame functions on Spark."""
