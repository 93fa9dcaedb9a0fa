"""docfacts.plans"""
