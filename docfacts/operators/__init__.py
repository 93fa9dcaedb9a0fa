"""docfacts.operators"""
