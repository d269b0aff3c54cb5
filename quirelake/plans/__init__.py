"""quirelake.plans"""
