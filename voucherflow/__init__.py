"""Coupon redemption analytics on Spark."""
